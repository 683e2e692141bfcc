"""Validation of payloads: required members, their kinds and allowed values, by event type.

Rules are rows of a small table (etype or ``*``, path, kind, allowed, required), so users bring their
own.  The payload is JSON text; one variant parse serves all rules, and the first rule that fails, in
table order, gives the message.  Members that no rule names are free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import once

#: One line a member: event type (* for all), path, kind (text, integer, boolean, list, object, or allowed values), and ! where required.
MEMBERS = """
* agent.id text
* integrity.hash text
* integrity.prev text
* integrity.stream text
* integrity.strength source_signed|export_anchored|export_chained
* acted_for list
SessionStart deployer.kind human|service|agent
SessionStart model_versions list
SessionEnd end_reason completed|interrupted|error|timeout
BundleLoaded components list
Attestation subject_digests list
Attestation verification.status verified|unverified|failed
ModelCall usage.input_tokens integer
ModelCall usage.output_tokens integer
ModelCall output_marking none|watermark|metadata|label
ToolCall tool.name text
ToolCall tool.protocol mcp|a2a|http|native
ToolCall side_effect none|read|write|external|irreversible
ToolCall effect_class read|write|irreversible|external_communication|spend|physical
ToolCall used list
ResourceAccess operation read|write|delete
ResourceAccess count integer
MemoryWrite trust trusted|untrusted|quarantined
MemoryWrite guard_verdict allow|sanitize|quarantine|block|review
MemoryRead trust_min trusted|untrusted|quarantined
Instruction source_class user|operator|service|agent_identified|agent_unidentified|tool_output|retrieved|memory_trusted|memory_untrusted
Refusal reason_class policy_conflict|scope_exceeded|unauthorized_principal|untrusted_source|budget_exceeded
PolicyDecision engine opa|cedar|openfga|governance_toolkit|custom
PolicyDecision decision allow|deny|require_approval|transform
AuthzCheck allowed boolean
DelegationIssued chain list
DelegationIssued verification.status verified|unverified|failed
Decision affects_natural_person boolean
Decision legal_or_significant_effect boolean
Decision ai_role sole|recommendation|assist
Decision options list
Decision oversight_modality none|review_before|review_after|sampled|dual_control|interruptible
ApprovalDecided outcome approve|edit|reject
ApprovalDecided latency_ms integer
ApprovalDecided explanation_viewed boolean
Interrupt mechanism stop_button|kill_switch|circuit_breaker|manual
Interrupt effect halted|paused|degraded
Outcome adverse boolean
Outcome reversed boolean
Incident incident_class death_or_health|infrastructure_disruption|fundamental_rights|property_or_environment
Notice notice_type subject_of_ai_decision|explanation|adverse_action
Disclosure disclosure_type ai_interaction|synthetic_marking|deepfake_label
IntegrityResult status verified|verified_weak|gap|reordered|unsigned|time_suspect|failed
IntegrityResult first_bad_index integer
"""
#: Required members of an object that is there: path of the object, member.
NEEDED = (("agent", "id"), ("integrity", "hash"), ("integrity", "prev"), ("integrity", "stream"), ("integrity", "strength"), ("tool", "name"), ("resource", "uri"))
KINDS = ("text", "integer", "boolean", "list", "object")


def member_rules() -> list[dict]:
    """The shipped rules: etype, path, kind, allowed (of kind text)."""
    rows = []
    for line in MEMBERS.strip().splitlines():
        etype, path, kind = line.split()
        rows.append({"etype": etype, "path": path, "kind": kind if kind in KINDS else "text", "allowed": None if kind in KINDS else kind.split("|")})
    return rows


def fits(value: Column, kind: str) -> Column:
    """Whether a variant is of a kind; null where there is none."""
    s = F.schema_of_variant(value)
    return {"text": s == "STRING", "integer": s.isin("BIGINT", "DECIMAL(38,0)"), "boolean": s == "BOOLEAN", "list": s.startswith("ARRAY"), "object": s.startswith("OBJECT")}[kind]


def field(payload: Column, path: str, kind: str = "string") -> Column:
    """Value at a dotted path of a payload (variant), null where any step is missing or of another kind."""
    return F.try_variant_get(payload, "$." + path, kind)


def payload_errors(rows: DataFrame, rules: list[dict] | None = None, data: str = "data") -> DataFrame:
    """Adds ``errors``, all messages in rule order, to rows with etype and a JSON payload; empty where it is valid."""
    v = F.col("_payload")
    out = rows.select("*", once(F.try_parse_json(F.col(data))).alias("_payload"))
    at = lambda path: F.try_variant_get(v, "$." + path, "variant")
    tests = [F.when(~F.coalesce(fits(v, "object"), F.lit(False)), "payload is no object")]
    for r in rules if rules is not None else member_rules():
        value = at(r["path"])
        message = F.when(~fits(value, r["kind"]), f"{r['path']} is not of kind {r['kind']}")
        if r.get("allowed"):
            message = message.when(~field(v, r["path"]).isin(r["allowed"]), f"{r['path']} has no allowed value")
        if r.get("required"):
            message = message.when(value.isNull(), f"{r['path']} is missing")
        tests.append(message if r["etype"] == "*" else F.when(F.col("etype") == r["etype"], message))
    for owner, member in NEEDED if rules is None else ():
        tests.append(F.when(fits(at(owner), "object") & at(f"{owner}.{member}").isNull(), f"{owner}.{member} is missing"))
    return out.select(*rows.columns, once(F.array_compact(F.array(*tests))).alias("errors"))


def with_stream(rows: DataFrame, data: str = "data") -> DataFrame:
    """Adds ``stream``: the payload's own, a non-empty text, else the source."""
    own = field(F.try_parse_json(F.col(data)), "integrity.stream")
    return rows.withColumn("stream", F.coalesce(F.nullif(own, F.lit("")), F.col("source")))


def projected(rows: DataFrame, paths: dict[str, str], data: str = "data") -> DataFrame:
    """Adds a text column for each (name, dotted path) of the payload, as metrics filter and group by."""
    out = rows.select("*", once(F.try_parse_json(F.col(data))).alias("_payload"))
    return out.withColumns({name: field(F.col("_payload"), path) for name, path in paths.items()}).drop("_payload")
