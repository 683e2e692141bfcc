"""Source logs to canonical events: flat maps with a reason for every row that gives none.

Each adapter is a function DataFrame -> DataFrame with the columns of ``EVENT`` and ``reason``; rows
with a reason are the reject output.  ``ADAPTERS`` registers them by name; users may add their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import first_present, nanoseconds_to_time

EVENT = ["id", "etype", "time", "trace_id", "agent", "detail"]

_PLAIN = "stringValue:string,intValue:string,boolValue:boolean,doubleValue:double"
VALUE = f"struct<{_PLAIN},arrayValue:struct<values:array<struct<{_PLAIN}>>>,kvlistValue:struct<values:array<struct<key:string,value:struct<{_PLAIN}>>>>>"
SPANS = (
    "resourceSpans array<struct<resource:struct<attributes:array<struct<key:string,value:" + VALUE + ">>>,schemaUrl:string,"
    "scopeSpans:array<struct<scope:struct<name:string,version:string>,spans:array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,"
    "startTimeUnixNano:string,endTimeUnixNano:string,attributes:array<struct<key:string,value:" + VALUE + ">>,status:struct<code:int,message:string>>>>>>>"
)
#: Span operations and the event they become; two become a start and an end.
OPERATIONS = {
    "chat": "ModelCall",
    "text_completion": "ModelCall",
    "generate_content": "ModelCall",
    "embeddings": "ModelCall",
    "execute_tool": "ToolCall",
    "retrieval": "ResourceAccess",
    "create_memory": "MemoryWrite",
    "update_memory": "MemoryWrite",
    "search_memory": "MemoryRead",
}
SESSIONS = ["invoke_agent", "invoke_workflow"]


def attribute_map(attributes: Column) -> Column:
    """Tagged values as text by key, lists and key-value lists as JSON text; the last of equal keys holds."""
    plain = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["boolValue"].cast("string"), v["doubleValue"].cast("string"))
    listed = lambda v: F.to_json(F.transform(v["arrayValue"]["values"], plain))
    keyed = lambda v: F.to_json(F.map_from_entries(F.transform(F.filter(v["kvlistValue"]["values"], lambda e: e["key"].isNotNull()), lambda e: F.struct(e["key"], plain(e["value"])))))
    text = lambda v: F.coalesce(plain(v), listed(v), keyed(v))
    pairs = F.coalesce(attributes, F.array().cast(f"array<struct<key:string,value:{VALUE}>>"))
    last = F.filter(pairs, lambda a, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda b: b["key"] == a["key"]))
    return F.map_from_entries(F.transform(F.filter(last, lambda a: a["key"].isNotNull()), lambda a: F.struct(a["key"], text(a["value"]))))


def unnest_spans(documents: DataFrame) -> DataFrame:
    """Span documents (``doc`` JSON text) to one row a span; the span's attributes win over the resource's."""
    one = documents.select(F.explode(F.from_json("doc", SPANS)["resourceSpans"]).alias("r"))
    two = one.select("r.schemaUrl", F.col("r.resource.attributes").alias("shared"), F.explode("r.scopeSpans").alias("s"))
    three = two.select("schemaUrl", "shared", F.col("s.scope").alias("scope"), F.explode("s.spans").alias("x"))
    none = F.array().cast(f"array<struct<key:string,value:{VALUE}>>")
    both = F.concat(F.coalesce("shared", none), F.coalesce(F.col("x.attributes"), none))
    version = F.coalesce(F.nullif(F.regexp_extract("schemaUrl", r"/(\d+\.\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(F.col("scope.version"), r"^(\d+\.\d+)", 1), F.lit("")))
    return three.select(
        F.col("x.traceId").alias("trace_id"), F.col("x.spanId").alias("span_id"), F.col("x.parentSpanId").alias("parent_id"), F.col("x.name").alias("name"),
        F.col("x.startTimeUnixNano").try_cast("long").alias("start_ns"), F.col("x.endTimeUnixNano").try_cast("long").alias("end_ns"), attribute_map(both).alias("attributes"), F.col("x.status").alias("status"), version.alias("convention"),
    )


def spans_to_events(spans: DataFrame, subject: str, source_class: str, source: str) -> DataFrame:
    """Events of spans; a session span gives a start and an end, a span without start uses its end."""
    a = F.col("attributes")
    op = F.coalesce(first_present(a, "gen_ai.operation.name"), F.substring_index("name", " ", 1))
    start = nanoseconds_to_time(F.coalesce("start_ns", "end_ns"))
    end = nanoseconds_to_time(F.coalesce("end_ns", "start_ns"))
    etype = F.coalesce(*[F.when(op == k, v) for k, v in OPERATIONS.items()])
    row = lambda part, t, at, detail: F.struct(F.lit(part).alias("part"), t.alias("etype"), at.alias("time"), detail.alias("detail"))
    failed = F.when(F.col("status.code") == 2, "error").otherwise("completed")
    session = op.isin(SESSIONS)
    target = first_present(a, "gen_ai.tool.name", "gen_ai.request.model", "gen_ai.data_source.id")
    rows = F.when(session, F.array(row("start", F.lit("SessionStart"), start, F.lit(None).cast("string")), row("end", F.lit("SessionEnd"), end, failed))).otherwise(F.array(row("event", etype, start, target)))
    out = spans.select("trace_id", "span_id", first_present(a, "gen_ai.agent.id", "gen_ai.agent.name").alias("agent"), F.explode(rows).alias("e"))
    reason = F.when(F.col("e.etype").isNull(), "unknown_operation").when(F.col("e.time").isNull(), "no_time").when(F.col("trace_id").isNull() | F.col("span_id").isNull(), "no_identity")
    ident = F.concat(F.lit("otel:"), F.col("trace_id"), F.lit("/"), F.col("span_id"), F.lit("#"), F.col("e.part"))
    return out.select(ident.alias("id"), F.col("e.etype").alias("etype"), F.col("e.time").alias("time"), "trace_id", "agent", F.col("e.detail").alias("detail"), reason.alias("reason")).withColumns({"subject": F.lit(subject), "source_class": F.lit(source_class), "source": F.lit(source)})


def conversation_spans(conversations: DataFrame) -> DataFrame:
    """Span documents of conversations: one document a turn, traces by conversation (test data for the adapter)."""
    op = F.when(F.col("role") == "assistant", "chat").when(F.col("role") == "user", "execute_tool").otherwise("invoke_agent")
    value = lambda v: F.struct(v.cast("string").alias("stringValue"))
    attribute = lambda k, v: F.struct(F.lit(k).alias("key"), value(v).alias("value"))
    ns = (F.lit(1_700_000_000) + F.col("conv_id") * 60 + F.col("turn")) * 1_000_000_000
    span = F.struct(F.concat(F.lit("t"), "conv_id").alias("traceId"), F.concat(F.lit("s"), "turn").alias("spanId"), op.alias("name"), ns.cast("string").alias("startTimeUnixNano"), F.array(attribute("gen_ai.operation.name", op), attribute("gen_ai.agent.id", F.lit("agent-otel"))).alias("attributes"))
    scope = F.struct(F.struct(F.lit("demo").alias("name"), F.lit("1.30.0").alias("version")).alias("scope"), F.array(span).alias("spans"))
    return conversations.where("conv_id is not null").select(F.to_json(F.struct(F.array(F.struct(F.array(scope).alias("scopeSpans"))).alias("resourceSpans"))).alias("doc"))


def _json(path: str) -> Column:
    return F.get_json_object("line", f"$.{path}")


def gateway_to_events(lines: DataFrame) -> DataFrame:
    """Gateway lines: a policy decision, the call unless it was denied, and a delegation; they name each other."""
    trace, span, at = _json("trace_id"), _json("span_id"), _json("timestamp")
    base = F.concat(F.lit("gw:"), trace, F.lit("/"), span)
    denied = _json("policy.decision") == "deny"
    call = F.when(_json("request.method") == "resources/read", "ResourceAccess").when(_json("request.method") == "tools/call", "ToolCall")
    part = lambda test, etype, name, detail: F.when(test, F.struct(F.concat(base, F.lit(f"#{name}")).alias("id"), etype.alias("etype"), detail.alias("detail")))
    rows = F.array_compact(
        F.array(
            part(_json("policy.decision").isNotNull(), F.lit("PolicyDecision"), "policy", _json("policy.decision")),
            part(call.isNotNull() & ~F.coalesce(denied, F.lit(False)), call, "call", _json("request.params.name")),
            part(_json("delegation.token_ref").isNotNull(), F.lit("DelegationIssued"), "delegation", _json("delegation.token_ref")),
        )
    )
    bad = F.when(F.get_json_object("line", "$").isNull(), "malformed").when(at.isNull() | trace.isNull() | span.isNull() | _json("gateway").isNull(), "missing_member").when(F.size(rows) == 0, "nothing_to_report")
    return _flat(lines, rows, bad, at, trace, _json("agent.id"))


def identity_to_events(lines: DataFrame) -> DataFrame:
    """Identity lines: a delegation with its chain; chain entries without a known kind are dropped."""
    chain = F.from_json(_json("chain"), "array<struct<id:string,kind:string,role:string>>")
    kept = F.filter(chain, lambda c: c["kind"].isin("human", "service", "agent") & c["id"].isNotNull())
    rows = F.array(F.struct(F.concat(F.lit("id:"), _json("token_ref")).alias("id"), F.lit("DelegationIssued").alias("etype"), F.array_join(F.transform(kept, lambda c: c["id"]), ">").alias("detail")))
    bad = F.when(F.get_json_object("line", "$").isNull(), "malformed").when(_json("token_ref").isNull(), "missing_member").when(_json("timestamp").isNull(), "no_time")
    return _flat(lines, rows, bad, _json("timestamp"), _json("trace_id"), _json("actor"))


#: Kinds of oversight lines and the event they become.
OVERSIGHT = {"approval_requested": "ApprovalRequested", "approval_decided": "ApprovalDecided", "override": "Override", "interrupt": "Interrupt", "outcome": "Outcome"}


def oversight_to_events(lines: DataFrame) -> DataFrame:
    """Oversight lines: approvals, overrides and interrupts need an actor with id, role and authority."""
    etype = F.coalesce(*[F.when(_json("kind") == k, v) for k, v in OVERSIGHT.items()])
    ident = F.coalesce(_json("id"), F.concat_ws("/", _json("trace_id"), _json("span_id")))
    actor = _json("actor.id").isNotNull() & _json("actor.role").isNotNull() & _json("actor.authority_ref").isNotNull()
    needs = etype.isin("ApprovalDecided", "Override", "Interrupt")
    bad = F.when(F.get_json_object("line", "$").isNull(), "malformed").when(_json("timestamp").isNull() | (ident == "") | _json("source_format").isNull(), "missing_member").when(etype.isNull(), "unknown_kind").when(needs & ~actor, "unattributed")
    return _flat(lines, F.array(F.struct(F.concat(F.lit("ov:"), ident).alias("id"), etype.alias("etype"), _json("actor.id").alias("detail"))), bad, _json("timestamp"), _json("trace_id"), _json("agent"))


#: How engines spell a decision.
DECISIONS = {"allow": "allow", "allowed": "allow", "permit": "allow", "true": "allow", "deny": "deny", "denied": "deny", "forbid": "deny", "false": "deny", "require_approval": "require_approval", "transform": "transform"}


def policy_to_events(lines: DataFrame) -> DataFrame:
    """Policy lines of several engines: relation checks and policy decisions under one spelling."""
    said = F.lower(F.coalesce(_json("decision"), _json("result"), _json("allowed")))
    word = F.coalesce(*[F.when(said == k, v) for k, v in DECISIONS.items()])
    check = _json("tuple_key").isNotNull()
    ident = F.coalesce(_json("id"), F.sha2("line", 256))
    bad = F.when(F.get_json_object("line", "$").isNull(), "malformed").when(_json("timestamp").isNull(), "no_time").when(word.isNull(), "unknown_decision")
    row = F.struct(F.concat(F.lit("pol:"), ident).alias("id"), F.when(check, "AuthzCheck").otherwise("PolicyDecision").alias("etype"), word.alias("detail"))
    return _flat(lines, F.array(row), bad, _json("timestamp"), _json("trace_id"), F.coalesce(_json("tuple_key.user"), _json("principal")))


def supply_to_events(lines: DataFrame, trusted: list[str]) -> DataFrame:
    """Supply-chain lines: loads, and attestations with the status of their signature."""
    names = lambda c: F.array_sort(F.array_distinct(F.from_json(_json(c), "array<string>")))
    status = F.when(_json("signature.key_id").isNull(), "unverified").when(~_json("signature.key_id").isin(trusted) | ~names("subject_digests").eqNullSafe(names("observed_digests")), "failed").otherwise("verified")
    etype = F.when(_json("kind") == "bundle_loaded", "BundleLoaded").when(_json("kind") == "attestation", "Attestation")
    bad = F.when(F.get_json_object("line", "$").isNull(), "malformed").when(etype.isNull(), "unknown_kind").when(_json("timestamp").isNull(), "no_time")
    row = F.struct(F.concat(F.lit("sc:"), F.sha2("line", 256)).alias("id"), etype.alias("etype"), F.when(etype == "Attestation", status).alias("detail"))
    return _flat(lines, F.array(row), bad, _json("timestamp"), _json("trace_id"), _json("agent"))


def _flat(lines: DataFrame, rows: Column, bad: Column, at: Column, trace: Column, agent: Column) -> DataFrame:
    """One row an event, or one row with the reason where the line gives none."""
    one = F.when(bad.isNull(), rows)
    out = lines.select(at.alias("time"), trace.alias("trace_id"), agent.alias("agent"), bad.alias("reason"), F.explode_outer(one).alias("e"))
    return out.select("e.id", "e.etype", "time", "trace_id", "agent", "e.detail", "reason")


def report(events: DataFrame) -> DataFrame:
    """(reason, rows): emitted events under null, skipped lines under their reason."""
    return events.groupBy("reason").agg(F.count("*").alias("rows"))


def source_counts(events: DataFrame) -> DataFrame:
    """Events per type: an independent count to hold other sources against."""
    return events.where("reason is null").groupBy("etype").agg(F.count("*").alias("n"))


ADAPTERS: dict[str, Callable[..., DataFrame]] = {"gateway": gateway_to_events, "identity": identity_to_events, "oversight": oversight_to_events, "policy": policy_to_events, "supply": supply_to_events}
