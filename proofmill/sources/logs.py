"""Gateway and identity logs to events with their whole payloads.

A gateway line gives up to three events that name each other: the policy decision, the call unless it
was denied, and the delegation it carries.  An identity line gives the delegation alone.  Chains keep
who, what kind, role, authority and organisation; entries of no known kind are left out.  Content is
never copied: a payload names where in the log it stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import once
from .payload import EVENT, text
from .spans import some

#: What members may hold; another value counts as missing.
ENGINES = ["opa", "cedar", "openfga", "governance_toolkit", "custom"]
DECISIONS = ["allow", "deny", "require_approval", "transform"]
KINDS = ["human", "service", "agent"]
SIDE_EFFECTS = ["none", "read", "write", "external", "irreversible"]
EFFECT_CLASSES = ["read", "write", "irreversible", "external_communication", "spend", "physical"]
STATUSES = ["verified", "unverified", "failed"]
#: Fixed value: the protocol version of lines that name none.
PROTOCOL = "2025-06-18"
ENVELOPE = ["id", "source", "subject", "time", "etype", "source_class", "convention", "trace_id", "span_id", "parent_id", "task", "reason"]

LINE = "_v"


def at(path: str, v: Column | str = LINE) -> Column:
    return F.try_variant_get(v, f"$.{path}", "variant")


def texts(vs: Column) -> Column:
    """The texts of a list of variants, null in the place of what is empty or no text."""
    return F.transform(F.transform(vs, text), lambda x: F.nullif(x, F.lit("")))


class Members:
    """The members of a line that a query names: each is read once, into a list, however often it is named.

    ``lists`` gives the columns of these lists, which ``laid_out`` adds to the parsed lines.
    """

    def __init__(self) -> None:
        self.kinds: dict[str, dict[str, int]] = {"_texts": {}, "_names": {}, "_objects": {}, "_who": {}, "_chains": {}}

    def _nth(self, kind: str, path: str) -> Column:
        return F.get(kind, F.lit(self.kinds[kind].setdefault(path, len(self.kinds[kind]))))

    def named(self, path: str) -> Column:
        """The text at a path, null where it is empty or no text."""
        return self._nth("_texts", path)

    def names(self, path: str) -> Column:
        """The texts of the list at a path, null where there is none."""
        return self._nth("_names", path)

    def there(self, path: str) -> Column:
        """Whether an object with members stands at a path."""
        return F.coalesce(self._nth("_objects", path) > 0, F.lit(False))

    def who(self, path: str) -> Column:
        """The principal at a path."""
        return self._nth("_who", path)

    def chain(self, path: str) -> Column:
        """The principals of the list at a path, null where there is none."""
        return self._nth("_chains", path)

    def lists(self) -> list[Column]:
        some_of = lambda xs: F.transform(F.array(xs), lambda a: F.when(F.size(a) > 0, a))[0]
        listed = lambda p: F.try_variant_get(LINE, f"$.{p}", "array<variant>")
        make = {
            "_texts": lambda ps: texts(F.array(*map(at, ps))),
            "_names": lambda ps: F.array(*[some_of(F.array_compact(texts(listed(p)))) for p in ps]),
            "_objects": lambda ps: F.transform(F.array(*[F.try_variant_get(LINE, f"$.{p}", "map<string,variant>") for p in ps]), F.size),
            "_who": lambda ps: F.transform(F.array(*map(at, ps)), principal),
            "_chains": lambda ps: F.array(*[some_of(F.array_compact(F.transform(listed(p), principal))) for p in ps]),
        }
        return [once(make[kind](list(paths))).alias(kind) for kind, paths in self.kinds.items() if paths]


def one_of(value: Column, allowed: list[str]) -> Column:
    return F.when(value.isin(allowed), value)


def principal(v: Column) -> Column:
    """(id, kind, role, authority_ref, org) of an object with an id and a known kind, else null."""
    members = ("id", "kind", "role", "authority_ref", "org")
    who = lambda t: F.when(t[0].isNotNull() & t[1].isin(KINDS), F.struct(*[t[i].alias(m) for i, m in enumerate(members)]))
    return F.transform(F.array(texts(F.array(*[at(m, v) for m in members]))), who)[0]


def delegation(m: Members, prefix: str = "") -> dict[str, Column]:
    """Members of a delegation that stand below ``prefix``."""
    verified = some(one_of(m.named(f"{prefix}verification.status"), STATUSES).alias("status"), *[m.named(f"{prefix}verification.{x}").alias(x) for x in ("method", "log_ref")])
    own = {x: m.named(prefix + x) for x in ("token_ref", "issuer", "subject_principal", "actor_principal", "expires")}
    return {**own, "chain": m.chain(f"{prefix}chain"), "scope_granted": m.names(f"{prefix}scope_granted"), "scope_parent": m.names(f"{prefix}scope_parent"), "verification": verified}


def common(m: Members) -> dict[str, Column]:
    return {"agent": F.when(m.named("agent.id").isNotNull(), F.struct(m.named("agent.id").alias("id"), m.named("agent.name").alias("name"))), "acted_for": m.names("acted_for"), "session_id": m.named("session_id")}


def payload(m: Members, etype: str, members: dict[str, Column]) -> Column:
    return F.to_json(F.struct(F.lit(etype).alias("@type"), *[c.alias(name) for name, c in {**common(m), **members}.items()]))


def laid_out(lines: DataFrame, m: Members, events: Column, reason: Column, about: dict[str, Column]) -> DataFrame:
    """A row an event, or one with the reason why a line gives none; ``events`` is a list of (etype, id, data).

    A line is parsed once, and each member that ``m`` was asked for is read once from it.
    """
    nothing = F.array(F.struct(*[F.lit(None).cast("string").alias(c) for c in ("etype", "id", "data")]))
    rows = lines.select(once(F.try_parse_json("line")).alias(LINE))
    for c in m.lists():
        rows = rows.select("*", c)
    rows = rows.select(*[c.alias(n) for n, c in about.items()], reason.alias("reason"), once(events).alias("_events"))
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(F.size("_events") == 0, "nothing_to_report")))
    return rows.select("*", F.explode(F.when(F.col("reason").isNull(), F.col("_events")).otherwise(nothing)).alias("e")).select(*[F.col(f"e.{c}") if c in ("id", "etype") else F.col(c) for c in ENVELOPE], "e.data")


def refused(required: list[Column]) -> Column:
    missing = F.exists(F.array(*[c.isNull() for c in required]), lambda x: x)
    whole = F.try_variant_get(LINE, "$", "map<string,variant>").isNotNull()
    return F.when(F.col(LINE).isNull(), "malformed").when(~whole, "not_an_object").when(missing, "missing_member")


def about(m: Members, subject: str, source_class: str, source: Column, convention: Column) -> dict[str, Column]:
    fixed = {"source": source, "subject": F.lit(subject), "time": m.named("timestamp"), "source_class": F.lit(source_class), "convention": convention}
    return {**fixed, "trace_id": m.named("trace_id"), "span_id": m.named("span_id"), "parent_id": m.named("parent_span_id"), "task": m.named("task_id")}


def gateway_events(lines: DataFrame, subject: str, source_class: str, source: str | None = None, event: str = EVENT) -> DataFrame:
    """Events of gateway ``lines(line)``: envelope columns, the payload as JSON text in ``data``, and ``reason``."""
    m = Members()
    base = F.concat(F.lit("gw:"), m.named("trace_id"), F.lit("/"), m.named("span_id"))
    method = m.named("request.method")
    kind = F.when(method == "tools/call", "ToolCall").when(method == "resources/read", "ResourceAccess")
    ran = kind.isNotNull() & ~F.coalesce(m.named("policy.decision") == "deny", F.lit(False))
    place = lambda ref, content, name: F.coalesce(m.named(ref), F.when(at(content).isNotNull(), F.concat(base, F.lit(f"#{name}"))))
    allowed_by = F.when(m.there("policy"), F.struct(F.concat(F.lit(event), base, F.lit("#policy")).alias("authorization")))
    decision = {
        "engine": one_of(m.named("policy.engine"), ENGINES), **{x: m.named(f"policy.{x}") for x in ("policy_id", "policy_version", "policy_digest")}, "decision": one_of(m.named("policy.decision"), DECISIONS),
        "reasons": m.names("policy.reasons"), "obligations": m.names("policy.obligations"), "principal": m.who("policy.principal"), "refs": F.when(ran, F.struct(F.concat(F.lit(event), base).alias("request"))),
    }
    call = {
        "tool": F.struct(F.coalesce(m.named("request.params.name"), F.lit("unknown")).alias("name"), F.lit("mcp").alias("protocol"), F.coalesce(m.named("server"), m.named("request.params.server")).alias("server")),
        "args_ref": place("request.params.arguments_ref", "request.params.arguments", "args"), "result_ref": place("response.result_ref", "response.result", "result"),
        "side_effect": one_of(m.named("effect.side_effect"), SIDE_EFFECTS), "effect_class": one_of(m.named("effect.effect_class"), EFFECT_CLASSES),
        "error": F.when(m.named("response.outcome") == "error", F.coalesce(m.named("response.error.message"), F.lit("error"))), "refs": allowed_by,
    }
    access = {"resource": F.struct(F.coalesce(m.named("request.params.uri"), F.lit("unknown")).alias("uri"), m.named("request.params.kind").alias("kind")), "operation": F.lit("read"), "refs": allowed_by}
    one = lambda test, etype, ident, data: F.when(test, F.struct(F.lit(etype).alias("etype"), ident.alias("id"), data.alias("data")))
    events = F.array_compact(
        F.array(
            one(m.there("policy"), "PolicyDecision", F.concat(base, F.lit("#policy")), payload(m, "PolicyDecision", decision)),
            one(ran & (kind == "ToolCall"), "ToolCall", base, payload(m, "ToolCall", call)),
            one(ran & (kind == "ResourceAccess"), "ResourceAccess", base, payload(m, "ResourceAccess", access)),
            one(m.there("delegation"), "DelegationIssued", F.concat(base, F.lit("#delegation")), payload(m, "DelegationIssued", delegation(m, "delegation."))),
        )
    )
    own = F.lit(source) if source else F.concat(F.lit("urn:gateway:"), m.named("gateway"))
    convention = F.concat(F.lit("mcp:"), F.coalesce(m.named("protocol_version"), F.lit(PROTOCOL)))
    return laid_out(lines, m, events, refused([m.named(x) for x in ("timestamp", "trace_id", "span_id", "gateway")]), about(m, subject, source_class, own, convention))


def identity_events(lines: DataFrame, subject: str, source_class: str, source: str | None = None) -> DataFrame:
    """Delegations of identity ``lines(line)``, each with its chain, scopes, expiry and verification."""
    m = Members()
    ident = F.coalesce(m.named("id"), F.concat(m.named("trace_id"), F.lit("/"), m.named("span_id")))
    one = F.struct(F.lit("DelegationIssued").alias("etype"), F.concat(F.lit("id:"), ident).alias("id"), payload(m, "DelegationIssued", delegation(m)).alias("data"))
    own = F.lit(source) if source else F.concat(F.lit("urn:identity:"), F.coalesce(m.named("system"), m.named("issuer"), F.lit("unknown")))
    convention = F.concat_ws(":", m.named("format"), m.named("convention_version"))
    return laid_out(lines, m, F.array(one), refused([m.named("timestamp"), ident, m.named("format"), m.named("token_ref")]), about(m, subject, source_class, own, convention))


#: Kinds of oversight lines and their events; what outcomes, mechanisms, effects and notices may be.
OVERSIGHT = {"approval_requested": "ApprovalRequested", "approval_decided": "ApprovalDecided", "override": "Override", "interrupt": "Interrupt", "notice": "Notice"}
OUTCOMES = ["approve", "edit", "reject"]
MECHANISMS, EFFECTS = ["stop_button", "kill_switch", "circuit_breaker", "manual"], ["halted", "paused", "degraded"]
NOTICES = ["subject_of_ai_decision", "explanation", "adverse_action"]


def oversight_events(lines: DataFrame, subject: str, source_class: str, source: str | None = None) -> DataFrame:
    """Events of oversight ``lines(line)``.  Decisions, overrides and interrupts must name an actor with role
    and authority, decisions a session too, or the line is incomplete_record; a line that says which decision
    or request it is about keeps that reference."""
    m = Members()
    kind = m.named("kind")
    etype = F.coalesce(*[F.when(kind == k, t) for k, t in OVERSIGHT.items()])
    ident = F.coalesce(m.named("id"), F.concat(m.named("trace_id"), F.lit("/"), m.named("span_id")))
    own_kind = F.coalesce(m.named("actor.kind"), F.lit("human"))
    who = F.struct(m.named("actor.id").alias("id"), own_kind.alias("kind"), *[m.named(f"actor.{x}").alias(x) for x in ("role", "authority_ref", "org")])
    known = m.named("actor.id").isNotNull() & m.named("actor.role").isNotNull() & m.named("actor.authority_ref").isNotNull() & own_kind.isin(KINDS)
    actor = F.when(known, who)
    latency = F.when(F.schema_of_variant(at("latency_ms")).isin("BIGINT", "DECIMAL(38,0)"), F.try_variant_get(LINE, "$.latency_ms", "bigint"))
    viewed = F.when(F.schema_of_variant(at("explanation_viewed")) == "BOOLEAN", F.try_variant_get(LINE, "$.explanation_viewed", "boolean"))
    plain = lambda *xs: {x: m.named(x) for x in xs}
    refs = {"refs": some(*[m.named(f"refs.{x}").alias(x) for x in ("decision", "request")])}
    members = {
        "ApprovalRequested": plain("explanation_ref", "requested_from", "channel", "deadline"),
        "ApprovalDecided": {"actor": actor, **plain("session_ref", "edits_ref"), "outcome": one_of(m.named("outcome"), OUTCOMES), "latency_ms": latency, "explanation_viewed": viewed},
        "Override": {"actor": actor, **plain("original", "replacement", "reason_code")},
        "Interrupt": {"actor": actor, "mechanism": one_of(m.named("mechanism"), MECHANISMS), "effect": one_of(m.named("effect"), EFFECTS)},
        "Notice": {**plain("person_ref", "delivered_at", "channel", "content_ref"), "notice_type": one_of(m.named("notice_type"), NOTICES)},
    }
    data = F.coalesce(*[F.when(etype == t, payload(m, t, {**ms, **refs})) for t, ms in members.items()])
    lacking = etype.isin("ApprovalDecided", "Override", "Interrupt") & ~known | (etype == "ApprovalDecided") & m.named("session_ref").isNull()
    reason = F.coalesce(refused([m.named("timestamp"), ident, kind, m.named("source_format")]), F.when(etype.isNull(), "unknown_kind").when(F.coalesce(lacking, F.lit(True)), "incomplete_record"))
    one = F.struct(etype.alias("etype"), F.concat(F.lit("ov:"), ident).alias("id"), data.alias("data"))
    own = F.lit(source) if source else F.concat(F.lit("urn:oversight:"), F.coalesce(m.named("system"), m.named("instance"), F.lit("unknown")))
    return laid_out(lines, m, F.array(one), reason, about(m, subject, source_class, own, F.concat_ws(":", m.named("source_format"), m.named("convention_version"))))
